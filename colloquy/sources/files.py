"""Files beside transcripts: compressed ones, installed artifacts, the archive."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import squeeze
from .base import DRIFT_BYTES, FILE_CAP, SourceDialect, existing

DESCRIPTION_CAP = 400


def listed(spark: SparkSession, glob: str, *roots: str) -> DataFrame:
    """path, bytes, mtime of files by name; of absent roots none. Contents aren't read."""
    there = existing(spark, *roots)
    if not there:
        return spark.createDataFrame([], "path string, bytes long, mtime timestamp")
    files = spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", True).load(there)
    return files.select("path", F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"))


def compressed_files(spark: SparkSession, *roots: str) -> DataFrame:
    """Transcripts that are there but can't be read, the newest first: a history that isn't empty."""
    return listed(spark, "*.jsonl.zst", *roots).orderBy(F.desc("mtime"), "path")


def _texts(spark: SparkSession, paths: list[str]) -> DataFrame:
    paths = existing(spark, *paths)
    if not paths:
        return spark.createDataFrame([], "source string, raw string")
    return spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("source"), F.col("value").alias("raw"))


def installed_skills(spark: SparkSession, mark: str, *roots: str) -> DataFrame:
    """name, description, source, minted of root/name/SKILL.md files. Those without a description are none; mark tells our own."""
    raw = _texts(spark, [f"{r.rstrip('/')}/*/SKILL.md" for r in roots])
    head = F.regexp_extract("raw", r"^---\n([\s\S]*?)\n---", 1)
    told = squeeze(F.regexp_extract(head, r"description:\s*([\s\S]*?)(?=\n[a-zA-Z-]+:|$)", 1))
    name = F.url_decode(F.element_at(F.split("source", "/"), -2))
    return raw.select(name.alias("name"), told.alias("description"), "source", F.contains("raw", F.lit(mark)).alias("minted")).where("description <> ''")


def installed_blocks(spark: SparkSession, mark: str, *roots: str) -> DataFrame:
    """The same of root/name.md files, whose description is their first paragraph that isn't headings or comments."""
    raw = _texts(spark, [f"{r.rstrip('/')}/*.md" for r in roots])
    body = F.regexp_replace("raw", r"<!--[\s\S]*?-->", "")
    parts = F.transform(F.split(body, r"\n\s*\n"), lambda p: squeeze(F.regexp_replace(p, r"(?m)^#+ .*$", "")))
    first = F.substring(F.get(F.filter(parts, lambda p: p != ""), F.lit(0)), 1, DESCRIPTION_CAP)
    name = F.regexp_replace(F.url_decode(F.element_at(F.split("source", "/"), -1)), r"\.md$", "")
    return raw.select(name.alias("name"), first.alias("description"), "source", F.contains("raw", F.lit(mark)).alias("minted")).where("description is not null")


def archive(spark: SparkSession, root: str, target: str, glob: str = "*.jsonl") -> None:
    """Appends the files below root that the archive (Parquet) doesn't have, or has in a shorter form.

    Transcripts only grow, so the longest form of a name is the latest. Only names and sizes are joined; the
    contents of what is new are read from the paths that are left.
    """
    base = spark._jvm.org.apache.hadoop.fs.Path(root)
    prefix = base.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(base).toString()
    flat = F.replace(F.substr("path", F.instr("path", base.toUri().getPath()) + F.lit(len(base.toUri().getPath().rstrip("/")) + 1)), F.lit("/"), F.lit("__"))
    live = listed(spark, glob, prefix).select("path", flat.alias("name"), "bytes", "mtime")
    if existing(spark, target):
        held = spark.read.parquet(target).groupBy("name").agg(F.max("bytes").alias("held"))
        live = live.join(held, "name", "left").where("held is null or held < bytes").drop("held")
    new = live.select("path").persist()
    try:
        for paths in _batches(new):
            contents = spark.read.format("binaryFile").load(paths)
            contents.select(flat.alias("name"), F.col("length").alias("bytes"), F.col("modificationTime").alias("mtime"), "content").write.mode("append").parquet(target)
    finally:
        new.unpersist()


def _batches(paths: DataFrame, most: int = 10_000) -> Iterator[list[str]]:
    """The paths, some at a time: a reader is given names by the driver, which never has them all."""
    some: list[str] = []
    for row in paths.toLocalIterator():
        some.append(row["path"])
        if len(some) == most:
            yield some
            some = []
    if some:
        yield some


def archived(spark: SparkSession, target: str) -> DataFrame:
    """The latest form of each archived file."""
    files = spark.read.parquet(target)
    last = files.groupBy("name").agg(F.max("bytes").alias("bytes"))
    return files.join(last, ["name", "bytes"], "left_semi")


def watch_typed(turns: DataFrame, seen: Observation) -> DataFrame:
    """turns, of which the typed ones are counted as whatever reads them reads them: no job of its own."""
    return turns.observe(seen, F.count_if((F.col("role") == "user") & ~F.coalesce("interrupted", F.lit(False)) & (F.col("text") != "")).alias("typed"))


def drifted(spark: SparkSession, dialect: SourceDialect, seen: Observation, least_bytes: int = DRIFT_BYTES) -> bool:
    """Whether so many bytes of transcripts without a typed message mean a changed format: sizes as listed, messages as they were read."""
    sizes = listed(spark, "*.jsonl", *dialect.roots).where(F.col("bytes") <= FILE_CAP).agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    return sizes >= least_bytes and seen.get["typed"] == 0
