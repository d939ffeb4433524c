"""Reading transcript files: lines with their place, file exclusion, registry of dialects."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F



FILE_CAP, LINE_CAP, DRIFT_BYTES = 96 << 20, 4 << 20, 500_000

TURN_COLUMNS = [
    "record", "path", "mtime", "line_no", "uuid", "session", "ts", "role", "text", "interrupted", "interrupt_kind", "pasted", "cwd", "git_branch",
    "tools", "delegations", "skills", "delegation_count", "skill_count", "denial", "denied_tools", "images",
]


def existing(spark: SparkSession, *roots: str) -> list[str]:
    """The roots (folders, files or globs) that are there: a tool that was never used has no folder."""
    conf, found = spark._jsc.hadoopConfiguration(), []
    for root in roots:
        path = spark._jvm.org.apache.hadoop.fs.Path(root)
        if path.getFileSystem(conf).globStatus(path):
            found.append(root)
    return found


def read_lines(spark: SparkSession, *roots: str, file_cap: int = FILE_CAP) -> DataFrame:
    """path, mtime, bytes, line_no, value of every line of the .jsonl files below the roots; of absent roots none.

    Files above the cap are left out by their listed size, lines above the cap as they are read. Spark cuts
    files into splits of spark.sql.files.maxPartitionBytes. A line's number is its place in its split, and
    the lines of the splits before: counts by split, summed up within each file. A last line without its
    end is a line; if it was torn, it is no JSON, and the dialects leave it out.
    """
    there, schema = existing(spark, *roots), "path string, mtime timestamp, bytes long, line_no long, value string"
    if not there:
        return spark.createDataFrame([], schema)
    reader = spark.read.options(recursiveFileLookup=True, pathGlobFilter="*.jsonl", lineSep="\n")
    meta = {"path": "file_path", "mtime": "file_modification_time", "bytes": "file_size", "split": "file_block_start"}
    lines = reader.text(there).select("value", *[F.col(f"_metadata.{m}").alias(c) for c, m in meta.items()]).withColumn("row", F.monotonically_increasing_id())
    lines = lines.where(F.col("bytes") <= file_cap)
    splits = lines.groupBy("path", "split").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))
    before = F.sum("n").over(Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1))
    splits = splits.select(F.col("path").alias("of"), F.col("split").alias("at"), (F.coalesce(before, F.lit(0)) - F.col("first")).alias("shift"))
    lines = lines.where((F.trim("value") != "") & (F.length("value") <= LINE_CAP)).join(splits, (F.col("path") == F.col("of")) & (F.col("split") == F.col("at")))
    return lines.select("path", "mtime", "bytes", (F.col("row") + F.col("shift")).alias("line_no"), "value")


def file_name(path: Column) -> Column:
    """The name of a transcript's file, by which its session goes."""
    return F.regexp_extract(path, "([^/]*?)(\\.jsonl)?$", 1)


def by_file(turns: DataFrame) -> DataFrame:
    """turns as pairing takes them: a session is a file, whatever ids its rows carry, in the order of lines."""
    return turns.withColumns({"session": file_name(F.col("path")), "pos": F.col("line_no")})


def newest_first(*extra: str) -> Window:
    return Window.partitionBy(*extra).orderBy(F.desc("mtime"), "path", "line_no")


def first_by(rows: DataFrame, key: str) -> DataFrame:
    """One row for each key, the first of the newest file; rows without a key all stay."""
    keyed = rows.where(F.coalesce(F.col(key), F.lit("")) != "")
    keyed = keyed.withColumn("__n", F.row_number().over(newest_first(key))).where("__n = 1").drop("__n")
    return keyed.unionByName(rows.where(F.coalesce(F.col(key), F.lit("")) == ""))


def without_archived_twins(files: DataFrame, live: DataFrame) -> DataFrame:
    """Archived files (flat_name) of which no live file (relative path) is the original."""
    return files.join(live.select(F.replace("relative", F.lit("/"), F.lit("__")).alias("flat_name")), "flat_name", "left_anti")


def drift(lines: DataFrame, turns: DataFrame, least_bytes: int = DRIFT_BYTES) -> DataFrame:
    """One row: bytes and typed messages, and whether so many bytes without any message mean a changed format."""
    size = lines.select("path", "bytes").distinct().agg(F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes"))
    typed = turns.agg(F.count_if((F.col("role") == "user") & ~F.col("interrupted") & (F.col("text") != "")).alias("typed"))
    return size.join(typed).withColumn("drifted", (F.col("bytes") >= least_bytes) & (F.col("typed") == 0))


@dataclass(frozen=True)
class SourceDialect:
    """A transcript format: its roots, and how its lines become turns."""

    record: str
    roots: tuple[str, ...]
    turns: Callable[[DataFrame, str], DataFrame]

    def read(self, spark: SparkSession) -> DataFrame:
        return self.turns(read_lines(spark, *self.roots), self.record)


def detect(spark: SparkSession, dialects: list[SourceDialect]) -> list[SourceDialect]:
    """The dialects that have a root on this machine, in the order of the registry."""
    return [d for d in dialects if existing(spark, *d.roots)]


def all_turns(spark: SparkSession, dialects: list[SourceDialect]) -> DataFrame:
    out = None
    for dialect in dialects:
        turns = dialect.read(spark)
        out = turns if out is None else out.unionByName(turns)
    if out is None:
        raise ValueError("no dialects")
    return out


def record_of(path: Column, dialects: list[SourceDialect]) -> Column:
    """The record whose root is the longest beginning of a path; the first record if there is none."""
    roots = sorted(((r.rstrip("/") + "/", d.record) for d in dialects for r in d.roots), key=lambda x: (-len(x[0]), x[0]))
    out = F.lit(dialects[0].record)
    for root, record in reversed(roots):
        out = F.when(path.startswith(root), record).otherwise(out)
    return out


