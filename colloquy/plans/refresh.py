"""Incremental refresh: ingest new moments, build the model once, place what comes later."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions.text import shape
from ..operators import metrics, phrases, state, vectors
from ..operators.exchanges import new_rows, pair_exchanges, to_moments
from ..operators.mirror import counted_quantiles
from ..sources.files import watch_typed
from .store import MOMENTS_VERSION, SCHEMAS, Store

PIPELINE = "hash-384-v1"
Namer = Callable[[int], str]


def ingest(store: Store, turns: DataFrame, whole: bool = False, seen: Observation | None = None) -> None:
    """Append the moments that aren't stored yet; running it again appends nothing.

    whole: turns are all that a record has, not an increment. Then a record whose moments an older version
    wrote is built again; without it, older moments stay as they are. seen: counts the typed messages on the way.
    """
    fresh = to_moments(pair_exchanges(watch_typed(turns, seen) if seen else turns))
    records = [row[0] for row in turns.select("record").distinct().collect()]  # one for each source of transcripts
    stored = {record: store.version(record) for record in records}
    has = {row[0] for row in store.read("moments").select("record").distinct().collect()}
    stale = [r for r in records if whole and r in has and (stored[r] or 0) < MOMENTS_VERSION]
    fresh = fresh.withColumn("__n", F.row_number().over(Window.partitionBy("record", "key").orderBy(F.desc("ts"), "session"))).where("__n = 1").drop("__n")
    if stale:
        store.replace("moments", fresh.where(F.col("record").isin(stale)))
        fresh = fresh.where(~F.col("record").isin(stale))
    store.append("moments", new_rows(fresh, store.read("moments"), ["record", "key"]))
    new = [(MOMENTS_VERSION, r) for r in records if r in stale or r not in has]
    if new:
        store.replace("versions", store.spark.createDataFrame(new, SCHEMAS["versions"]))


def shaped_vectors(moments: DataFrame, words: DataFrame, embedder: vectors.Embedder | None = None) -> DataFrame:
    """Moments with vectors of their replies, of which only vocabulary words are left. words: a few hundred rows a record."""
    lists = words.groupBy("record").agg(F.collect_list("word").alias("words"))
    own = moments.join(F.broadcast(lists), "record", "left").withColumn("shaped", shape(F.col("reply"), F.coalesce("words", F.array().cast("array<string>"))))
    return vectors.embed(own.select("record", "key", "session", "pile", "ts", "shaped"), "shaped", embedder=embedder)


def cold_build(store: Store, record: str, namer: Namer = "behaviour {}".format) -> int:
    """Vocabulary, vectors, clusters, names and assignments of a record, all anew. Returns the number of categories.

    Categories of builds before end, unless one of the same name is born again: events are numbered on from
    the greatest number, ends first.
    """
    moments = store.read("moments").where(F.col("record") == record)
    words = phrases.vocabulary(moments, ["record"], "reply")
    store.replace("vocabulary", words.withColumn("pipeline", F.lit(PIPELINE)))
    band = metrics.supported_clusters(moments, least=1).first()
    if band is None:
        return 0
    with store.held(shaped_vectors(moments, store.read("vocabulary").where(F.col("record") == record))) as placed:
        fits = vectors.cluster(placed.withColumnRenamed("key", "vec_id"), list(range(band["lo"], band["hi"] + 1)), order=["ts", "vec_id"])
        fit = vectors.derive_k(fits)
        centres, assigned_by = vectors.centres_of(fit), vectors.centres_of(fit, "before")
        with store.held(vectors.nearest_centre(placed, assigned_by.select("idx", "centre"), ["record", "key", "session", "pile"])) as near:
            kept = metrics.admitted(near.select("record", F.col("idx").alias("cluster"), "session", (F.col("pile") != "ordinary").alias("anchor")))
            kept = kept.select("record", F.col("cluster").alias("idx"), (F.row_number().over(Window.partitionBy("record").orderBy("cluster")) - 1).alias("place"))
            names = [namer(i) for i in range(kept.count())]  # 30 at most
            labels = store.spark.createDataFrame(list(enumerate(names)), "place int, label string")
            known = kept.join(F.broadcast(labels), "place").select("record", "idx", "place", "label")
            model = centres.join(known, ["record", "idx"]).select("record", F.col("place").alias("idx"), "label", "centre", F.lit(PIPELINE).alias("pipeline"))
            store.replace("centres", model)
            store.replace("assignments", as_assignments(near.join(known.select("record", "idx", "label"), ["record", "idx"], "left")))
    log = store.read("categories").where(F.col("record") == record)
    first = state.next_number(log)
    now, none = F.current_timestamp().alias("at"), F.lit("").alias("description")
    ended = state.fold_log(log, ["record", "name"], []).withColumn("n", F.row_number().over(Window.partitionBy("record").orderBy("name")))  # categories, a few dozen
    retired = ended.select("record", F.lit("retired").alias("event"), "name", none, now, (F.lit(first - 1) + F.col("n")).cast("long").alias("seq"))
    live = store.read("centres").where(F.col("record") == record)
    born = live.select("record", F.lit("born").alias("event"), F.col("label").alias("name"), none, now, (F.lit(first + ended.count()) + F.col("idx")).cast("long").alias("seq"))
    store.append("categories", retired.unionByName(born))
    built = moments.agg(F.countDistinct("session").alias("sessions")).select("sessions", F.unix_millis(F.current_timestamp()).alias("at_ms"), F.lit(PIPELINE).alias("pipeline"), F.unix_millis(F.current_timestamp()).alias("seq"), F.lit(record).alias("record"))
    store.append("builds", built)
    return len(names)


def compact_categories(store: Store) -> None:
    """The log of categories without what has ended; it folds as before, and numbers go on."""
    store.replace("categories", state.compact_log(store.read("categories"), ["record", "name"]))
    store.compact("categories")


def as_assignments(placed: DataFrame) -> DataFrame:
    """No kind is a kind of answer: an empty array, not a missing row."""
    kinds = F.when(F.col("label").isNull(), F.array().cast("array<string>")).otherwise(F.array("label"))
    return placed.select("record", "key", F.current_timestamp().alias("at"), kinds.alias("kinds"), F.xxhash64("key").alias("seq"))


def grow(store: Store, record: str) -> None:
    """Place the moments that have no assignment against the frozen centres."""
    moments = store.read("moments").where(F.col("record") == record)
    pending = new_rows(moments, store.read("assignments").where(F.col("record") == record), ["record", "key"])
    placed = shaped_vectors(pending, store.read("vocabulary").where(F.col("record") == record))
    centres = store.read("centres").where((F.col("record") == record) & (F.col("pipeline") == PIPELINE))
    near = vectors.nearest_centre(placed, centres.select("idx", "centre"), ["record", "key"])
    store.append("assignments", as_assignments(near.join(F.broadcast(centres.select("idx", "label")), "idx")))
    store.append("fits", fit_of(near))


def fit_of(near: DataFrame) -> DataFrame:
    """How near the placed moments are to their centres: one row for each record, none for none."""
    stats = counted_quantiles(near.withColumn("s", F.floor(F.col("sim") * 1000 + 0.5)), ["record"], "s", {"median": 0.5, "p10": 0.1})
    return stats.select(F.unix_millis(F.current_timestamp()).alias("at_ms"), "n", *[(F.col(c) / F.lit(1000.0)).alias(c) for c in ("median", "p10")], "record")


def outgrown(moments: DataFrame, sessions_at_build: int) -> bool:
    """Whether the supported number of clusters has doubled, and by three at least."""
    row = metrics.supported_clusters(moments, least=1).agg(F.max("sessions")).first()
    supported = lambda n: max(1, min(30, n // DEFAULT.min_sessions))
    now, then = supported(row[0] or 0), supported(sessions_at_build)
    return now >= 2 * then and now >= then + 3


def sessions_at_build(store: Store, record: str) -> int | None:
    return store.read("builds").where(F.col("record") == record).agg(F.max_by("sessions", "seq")).first()[0]


def refresh(store: Store, turns: DataFrame, record: str, rebuild: bool = False, whole: bool = False, namer: Namer = "behaviour {}".format) -> None:
    """Ingest; then build anew if asked to, without a model, or once the record has outgrown it, else place what is new."""
    ingest(store, turns, whole)
    then = sessions_at_build(store, record)
    rebuild = rebuild or (then is not None and outgrown(store.read("moments").where(F.col("record") == record), then))
    if rebuild or store.read("centres").where((F.col("record") == record) & (F.col("pipeline") == PIPELINE)).isEmpty():
        cold_build(store, record, namer)
    else:
        grow(store, record)


def labelled(store: Store, record: str) -> DataFrame:
    own = metrics.label(store.read("moments").where(F.col("record") == record), store.read("assignments"))
    return own.withColumn("ms", F.unix_millis(F.try_to_timestamp("ts")))
