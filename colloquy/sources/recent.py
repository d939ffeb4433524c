"""The latest exchanges of an archive, from as few of its newest files as hold them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.exchanges import holds_enough, pair_exchanges, recent_exchanges
from .base import SourceDialect, file_name, read_lines
from .files import listed

#: Files that are read first, and how many times as many each time they hold too little.
FIRST, GROWTH = 8, 4


def as_exchanges(turns: DataFrame) -> DataFrame:
    """Exchanges, paired within each file, with the file and time that recent_exchanges orders by. The session is the file's name."""
    own = turns.select("record", F.col("path").alias("session"), F.col("line_no").alias("pos"), "ts", "role", "text", "interrupted", "interrupt_kind", "denial", "denied_tools", "tools", "cwd", "git_branch", "images")
    times = turns.groupBy(F.col("path").alias("session")).agg(F.max("mtime").alias("mtime"))
    paired = pair_exchanges(own).join(times, "session").withColumnRenamed("session", "path")
    return paired.withColumn("session", file_name(F.col("path")))


def read_recent(spark: SparkSession, dialect: SourceDialect, want: int, margin: int = 4, first: int = FIRST) -> DataFrame:
    """The latest `want` exchanges of a dialect's files, as recent_exchanges has them of all files.

    Names, times and sizes are listed; then the newest files are read, more each time, until they hold so
    many distinct exchanges and there are `margin` files more, or all are read. A copy counts in its newest
    file, so older files change nothing in what newer ones hold. What is read follows `want`: at most the
    files needed and GROWTH times as many, and those of the tries before once more.
    """
    files = listed(spark, "*.jsonl", *dialect.roots).orderBy(F.desc("mtime"), "path")
    n, size = files.count(), first
    while True:
        paths = [row["path"] for row in files.limit(min(size, n)).collect()]  # the newest, as many as are read
        found = as_exchanges(dialect.turns(read_lines(spark, *paths), dialect.record)).persist()
        if size >= n or holds_enough(found, want, margin):
            return recent_exchanges(found, want, margin)
        found.unpersist()
        size *= GROWTH
