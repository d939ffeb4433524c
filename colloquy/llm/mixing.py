"""Operator 2, mixing sources to target weights by systematic sampling.

Within a source every document expects `target / source size` copies. The documents are put in an
order, their expected copies summed up along it, one random offset added, and a copy emitted for
every integer boundary that a document crosses. The order runs through classes of like size, so the
words taken follow the target closely. All documents of a source expect the same number of copies,
so the prefix sum is a rank times that number, and ranks come from slices of a source: no task
holds a source.

Defined results: a null text has size 0; a null source is a source of its own, the last; a null
doc_id sorts as -1; rows that are repeated count each; a source without words is never taken; an
empty table gives no rows. Input columns with the names of result columns are replaced.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, salted_ranks, set_aside, spread, words


@dataclass(frozen=True)
class Mix:
    #: Weights by the position of the source in code point order, repeating.
    weights: tuple[int, ...] = (3, 1, 2)
    #: Words to take, in percent of all words.
    percent: int = 150
    #: A target stops at so many times the source's size.
    most: int = 2
    seed: int = 20240


def source_targets(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """(source, source_size, target, offset) from rows with source and size.

    Filling up to a level: with the sources in the order of cap / weight, the level is what is left
    over the weights that are left, at the first source that it doesn't fill.
    """
    sources = sized.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    place = F.row_number().over(everything.orderBy(F.col("source").isNotNull().desc(), "source")) - 1
    own = sources.withColumn("k", place)
    own = own.withColumn("w", F.element_at(F.array(*[F.lit(x) for x in mix.weights]), (F.col("k") % len(mix.weights) + 1).cast("int")))
    own = own.withColumn("cap", F.col("source_size") * mix.most).withColumn("full_at", F.col("cap") / F.col("w"))
    fill = everything.orderBy("full_at", "k")
    own = own.withColumns(
        {
            "turn": F.row_number().over(fill),
            "filled": F.coalesce(F.sum("cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
            "left": F.sum("w").over(fill.rowsBetween(0, Window.unboundedFollowing)),
            "wanted": F.sum("source_size").over(everything) * mix.percent / 100,
        }
    )
    own = own.withColumn("level", (F.col("wanted") - F.col("filled")) / F.col("left"))
    first = F.min(F.when(F.col("level") <= F.col("full_at"), F.struct("turn", "level"))).over(everything)
    own = own.withColumn("level", first["level"])
    target = F.when(F.col("full_at") < F.col("level"), F.col("cap").cast("double")).otherwise(F.col("level") * F.col("w"))
    offset = F.pmod((F.col("k") + mix.seed) * F.lit(2654435761), F.lit(4294967296)) / F.lit(4294967296)
    return own.select("source", "source_size", target.alias("target"), offset.alias("offset"))


def with_copies(sized: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """sized (doc_id, source, size and any other columns) with source_size, target, copies, taken."""
    sized, named = set_aside(sized, "rank", "n", "offset", "level", "full_at", "cap", "w", "k")
    given = [c for c in sized.columns if c not in ("source_size", "target", "copies", "taken")]
    own = sized.select(*given).withColumns({"__class": F.floor(F.sqrt("size")), "__mix": spread(F.col("doc_id"))})
    own = materialize(own, "mix-sized")
    targets = materialize(source_targets(own, mix), "mix-targets").withColumnRenamed("source", "__of")
    ranked, classes = salted_ranks(own, ["source", "__class"], "__mix", ["size", "doc_id"], "mix")
    before = Window.partitionBy("source").orderBy("__class").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.withColumn("__before", F.coalesce(F.sum("n").over(before), F.lit(0)))
    classes = materialize(classes.select(F.col("source").alias("__s"), F.col("__class").alias("__c"), "__before"), "mix-classes")
    placed = ranked.join(classes, F.col("source").eqNullSafe(F.col("__s")) & (F.col("__class") == F.col("__c")))
    placed = placed.join(targets, F.col("source").eqNullSafe(F.col("__of")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    at = F.col("__before") + F.col("rank")
    copies = F.floor(rate * (at + 1) + F.col("offset")) - F.floor(rate * at + F.col("offset"))
    placed = placed.withColumn("copies", F.least(copies, F.lit(mix.most)).cast("long"))
    placed = placed.withColumn("taken", F.col("copies") * F.col("size"))
    return named(placed.select(*given, "source_size", "target", "copies", "taken"))


def with_size(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.size(words(F.col("text"))).cast("long"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix itself: every document as often as it is taken, with the columns of docs."""
    own = with_size(docs.select(F.struct(*docs.columns).alias("__doc"), "doc_id", "source", "text")).drop("text")
    own = materialize(own.withColumn("mix_row", F.monotonically_increasing_id()), "mix-docs")
    # Ranks need row numbers and sizes only. The documents are dealt out once, to meet their copies.
    taken = with_copies(own.drop("__doc"), mix).where(F.col("copies") > 0).select("mix_row", "copies")
    copies = own.select("mix_row", "__doc").join(taken.hint("shuffle_hash"), "mix_row")
    return copies.select("__doc", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("__doc.*")


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), placed AS (
  SELECT *, row_number() OVER (ORDER BY source IS NULL, source) - 1 AS k FROM sources
), weighed AS (
  SELECT *, [3, 1, 2][k % 3 + 1] AS w, source_size * 2 AS cap, (source_size * 2)::DOUBLE / [3, 1, 2][k % 3 + 1] AS full_at FROM placed
), filling AS (
  SELECT *, row_number() OVER fill AS turn,
    coalesce(sum(cap) OVER (ORDER BY full_at, k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS filled,
    (sum(w) OVER (ORDER BY full_at, k ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS left_over,
    (sum(source_size) OVER ())::DOUBLE * 150 / 100 AS wanted
  FROM weighed WINDOW fill AS (ORDER BY full_at, k)
), levelled AS (
  SELECT (wanted - filled) / left_over AS level FROM filling
  WHERE (wanted - filled) / left_over <= full_at ORDER BY turn LIMIT 1
), targets AS (
  SELECT source, source_size, CASE WHEN full_at < level THEN cap::DOUBLE ELSE level * w END AS target,
    (((k + 20240) * 2654435761) % 4294967296)::DOUBLE / 4294967296 AS o
  FROM filling, levelled
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY floor(sqrt(size)), h, size, doc_id NULLS FIRST) - 1 AS place FROM (
    SELECT *, (((coalesce(doc_id, -1) % 1000003 + 1000003) % 1000003) * 2654435761) % 4294967296 AS h FROM sized)
)
SELECT r.doc_id, r.size, t.source_size, t.target,
  CASE WHEN t.source_size = 0 THEN 0 ELSE
    least(floor(t.target / t.source_size * (place + 1) + o) - floor(t.target / t.source_size * place + o), 2)::BIGINT * r.size END::BIGINT AS taken
FROM ranked r JOIN targets t ON r.source IS NOT DISTINCT FROM t.source
"""
