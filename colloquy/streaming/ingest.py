"""Streaming ingest: transcripts as they arrive, in idempotent batches; and windowed counts of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from ..operators.exchanges import is_typed
from ..plans import refresh
from ..plans.store import Store

TURNS = (
    "record string, session string, pos long, ts string, role string, text string, interrupted boolean, interrupt_kind string, denial string, "
    "denied_tools array<string>, tools array<string>, cwd string, git_branch string, images int"
)


def stream_turns(spark: SparkSession, path: str) -> DataFrame:
    """Turns from JSON files as they are added below a folder."""
    return spark.readStream.schema(TURNS).json(path)


def follow(turns: DataFrame, store: Store, checkpoint: str) -> StreamingQuery:
    """Ingest what is there, then stop; started again, it goes on from there.

    Sessions arrive whole, a file each. Late and restored files count, so there is no watermark; a
    batch that runs twice appends nothing the second time, as stored keys are left out.
    """

    def batch(rows: DataFrame, _: int) -> None:
        own = rows.persist()
        refresh.ingest(store, own)
        for r in own.select("record").distinct().collect():
            if not store.read("centres").where(F.col("record") == r["record"]).isEmpty():
                refresh.grow(store, r["record"])
        own.unpersist()

    return turns.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def once(turns: DataFrame, keys: tuple[str, ...] = ("record", "session", "pos")) -> DataFrame:
    """A stream of turns of which each comes once: a file that is restored or replayed adds nothing.

    The keys seen are the stream's own state, so no table is scanned. Transcripts may be restored after
    any time, so keys are kept for good: some 50 bytes a turn, split over the tasks.
    """
    return turns.dropDuplicates(list(keys))


def activity(turns: DataFrame, gap: str = "30 minutes", late: str = "1 day") -> DataFrame:
    """(record, begin, end, turns, typed): spans of activity that end where nothing comes for `gap`.

    A late row joins its span, or makes one of two, for as long as the watermark waits; then a span is final.
    """
    timed = turns.withColumn("at", F.try_to_timestamp("ts")).where("at is not null").withWatermark("at", late)
    spans = timed.groupBy("record", F.session_window("at", gap).alias("w")).agg(F.count(F.lit(1)).alias("turns"), F.count_if(is_typed(F.col("role"), F.col("interrupted"), F.col("text"))).alias("typed"))
    return spans.select("record", F.col("w.start").alias("begin"), F.col("w.end").alias("end"), "turns", "typed")


def windowed_counts(events: DataFrame, size: str = "1 hour", late: str = "1 day") -> DataFrame:
    """An extension: counts by tumbling windows of event time, each event once, late ones up to the watermark."""
    own = events.withWatermark("ts", late).dropDuplicatesWithinWatermark(["event_id"])
    return own.groupBy(F.window("ts", size), "event_type").agg(F.count(F.lit(1)).alias("n"))
