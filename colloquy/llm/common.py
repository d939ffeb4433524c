"""What the training-data operators share: tables, shared scratch space, distributed ranks."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, nullcontext
from contextvars import ContextVar

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: ASCII white space, the separator of words everywhere in this subpackage.
SPACES = "[\\x20\\x09-\\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The shared folder of spark.checkpoint.dir. Only a local session may do without: there it is a temporary folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared:
        return shared.rstrip("/")
    if not spark.sparkContext.master.split("[")[0] == "local":
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return "file://" + os.path.join(tempfile.gettempdir(), "colloquy-scratch")


#: Where materialize writes; None: the shared folder itself.
_folder: ContextVar[str | None] = ContextVar("colloquy_folder", default=None)


@contextmanager
def scratch_folder(spark: SparkSession) -> Iterator[str]:
    """What is materialized within goes to a folder of its own, which the caller may remove once nothing reads it."""
    path = f"{scratch_dir(spark)}/colloquy-{uuid.uuid4().hex}"
    before = _folder.set(path)
    try:
        yield path
    finally:
        _folder.reset(before)


def set_aside(df: DataFrame, *inner: str) -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """df without columns named as an operator's own (`__...`, or one of inner), and what gives their names back.

    They are renamed, so they come along like any other column.
    """
    clashing = [c for c in df.columns if c.startswith("__") or c in inner]
    names = dict(zip(clashing, (n for n in (f"given_{i}" for i in range(len(df.columns) * 2 + 1)) if n not in df.columns)))
    back = {new: old for old, new in names.items()}
    return (df.withColumnsRenamed(names), lambda out: out.withColumnsRenamed(back)) if names else (df, lambda out: out)


#: Rows that go to a Python worker at once; texts may be long.
BATCH = ("spark.sql.execution.arrow.maxRecordsPerBatch", "256")


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """For what is planned within, few rows at once in Python workers."""
    before = spark.conf.get(BATCH[0])
    spark.conf.set(*BATCH)
    try:
        yield
    finally:
        spark.conf.set(BATCH[0], before)


#: Whether Spark removes a query's shuffle files once it is done, rather than when the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def no_shuffles_left(spark: SparkSession) -> Iterator[None]:
    """The shuffle files of what is written within are removed once it is written."""
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(CLEANUP, before)


def materialize(df: DataFrame, name: str, drop_shuffles: bool = False) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back.

    It cuts the lineage, survives lost executors, and gives the planner the measured size: a join
    broadcasts the table only if that size is under spark.sql.autoBroadcastJoinThreshold.
    """
    path = f"{_folder.get() or scratch_dir(df.sparkSession)}/colloquy-{name}-{uuid.uuid4().hex}"
    with small_batches(df.sparkSession), no_shuffles_left(df.sparkSession) if drop_shuffles else nullcontext():
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Remove a scratch folder or table."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def parallelism(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def words(text: Column) -> Column:
    """The words of a text, nulls as none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), SPACES), lambda w: w != "")


#: Second labels under which countries register domains (fixed values), as in example.co.uk.
REGISTRIES = "ac co com edu go gob gov gv ne net or org"


def host_levels(host: Column) -> tuple[Column, Column]:
    """Registered domain and public suffix of a host, without user and port; an address of digits is its own domain without a suffix."""
    suffix = rf"(?:{'|'.join(REGISTRIES.split())})\.[a-z]{{2}}|[^.]+"
    name = F.regexp_replace(F.regexp_replace(host, "^.*@", ""), ":[0-9]*$", "")
    digits = name.rlike(r"^[0-9.]*$|^\[")
    domain = F.regexp_extract(name, rf"((?:[^.]+\.)?(?:{suffix}))$", 1)
    return F.when(digits | (domain == ""), name).otherwise(domain), F.when(digits, "").otherwise(F.regexp_extract(name, rf"(?:^|\.)({suffix})$", 1))


def spread(key: Column) -> Column:
    """A 32-bit mix of an integer key that DuckDB can compute as well; null as -1."""
    return F.pmod(F.pmod(F.coalesce(key, F.lit(-1)), F.lit(1000003)) * F.lit(2654435761), F.lit(4294967296))


def salted_ranks(df: DataFrame, keys: list[str], salt: str, order: list[str], name: str) -> tuple[DataFrame, DataFrame]:
    """Number the rows of each key from 0 in the order (salt, *order), with no task per key.

    salt: a column of 32-bit integers. A key with many rows is cut into slices of the salt's range
    of a fair share of rows each; a slice is numbered by itself and starts where the slices before
    it end. Returns the rows with a column `rank`, and the table of the keys with their counts `n`.
    """
    spark = df.sparkSession
    counts = materialize(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")), f"{name}-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    share = max(1, total // (2 * parallelism(spark)))
    slices = counts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.ceil(F.col("n") / share).alias("__slices"))
    same = [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys]
    on = same[0]
    for x in same[1:]:
        on = on & x
    cut = df.join(slices, on).drop(*[f"__{k}" for k in keys])
    cut = cut.withColumn("__slice", F.floor(F.col(salt) * F.col("__slices") / F.lit(4294967296))).drop("__slices")
    before = Window.partitionBy(*keys).orderBy("__slice").rowsBetween(Window.unboundedPreceding, -1)
    starts = cut.groupBy(*keys, "__slice").agg(F.count(F.lit(1)).alias("__n"))
    starts = materialize(starts.withColumn("__start", F.coalesce(F.sum("__n").over(before), F.lit(0))).drop("__n"), f"{name}-starts")
    within = Window.partitionBy(*keys, "__slice").orderBy(salt, *order)
    numbered = cut.withColumn("__in_slice", F.row_number().over(within) - 1)
    starts = starts.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__slice").alias("__s"), "__start")
    numbered = numbered.join(starts, on & (F.col("__slice") == F.col("__s")))
    ranked = numbered.withColumn("rank", F.col("__start") + F.col("__in_slice"))
    return ranked.drop(*[f"__{k}" for k in keys], "__slice", "__s", "__start", "__in_slice"), counts
