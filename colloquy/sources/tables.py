"""Relational tables as turns and labelled moments."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.numbers import millis


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def conversation_turns(conversations: DataFrame, record: str = "chat") -> DataFrame:
    """Conversations (conv_id, turn, role, text) as turns; they have no times, tools, stops or refusals."""
    none = F.lit(None)
    return conversations.select(
        F.lit(record).alias("record"), F.col("conv_id").cast("string").alias("session"), F.col("turn").alias("pos"), F.lit("").alias("ts"), "role", F.coalesce("text", F.lit("")).alias("text"),
        F.lit(False).alias("interrupted"), none.cast("string").alias("interrupt_kind"), none.cast("string").alias("denial"), none.cast("array<string>").alias("denied_tools"),
        none.cast("array<string>").alias("tools"), none.cast("string").alias("cwd"), none.cast("string").alias("git_branch"), F.lit(0).alias("images"), "conv_id",
    )


def event_moments(events: DataFrame, record: str = "events") -> DataFrame:
    """Events as labelled moments: a user is a session, an error a stop, the type the kind, and the tool that ran."""
    number = F.get_json_object("props", "$.k").cast("long")
    return events.select(
        F.lit(record).alias("record"), F.col("user_id").cast("string").alias("session"), F.col("event_id").alias("key"), millis(F.col("ts")).alias("ms"), F.col("ts").cast("timestamp").alias("at"),
        F.when(F.col("event_type") == "error", "interrupt").otherwise("ordinary").alias("pile"), F.array("event_type").alias("kinds"), F.array(F.concat(F.lit("k"), (number % 10).cast("string"))).alias("tools"),
        F.when(F.col("event_type") == "error", F.array(F.concat(F.lit("k"), (number % 10).cast("string")))).otherwise(F.array().cast("array<string>")).alias("denied"),
        F.col("event_type"), "value", number.alias("k"),
    )
