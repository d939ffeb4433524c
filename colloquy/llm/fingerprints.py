"""Operator 7, document fingerprints by one-permutation MinHash.

The five-word shingles of a text are hashed once. The upper eight bits of a hash choose one of 256
bins, the least hash of a bin stands for it. Empty bins are filled by optimal densification: each
tries other bins in a random order of its own until one isn't empty, so two texts with the same
shingles there take the same one. A bin keeps its eight low-order bits, eight bins to a long.
Likeness is the share of equal bins, less what unequal bins have in common by chance.

DataFrame functions only. Sorting the hashes puts the least of each bin first in its run.

Defined results: a null or empty text is one shingle without words, like only to its equals; a text
of fewer than five words is one shingle. Documents are in descending doc_id, nulls last, rows of
equal doc_id in the order of their texts; after the last comes the first, so a document alone is
followed by itself. An empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import parallelism, words

SHINGLE, BINS, BITS = 5, 256, 8
#: Bins that an empty bin tries at random before it goes through all in its order.
PROBES = 6
LONGS = BINS * BITS // 64


def with_fingerprint(docs: DataFrame, text: str, name: str) -> DataFrame:
    """docs with the packed fingerprint, an array of longs, of a text column."""
    own = docs.withColumn("__w", words(F.col(text)))
    last = F.greatest(F.size("__w") - SHINGLE, F.lit(0))
    hashes = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get("__w", i + k) for k in range(SHINGLE)]))
    own = own.withColumn("__h", F.sort_array(hashes)).drop("__w")
    bin_of = lambda x: F.shiftright(x, 56)  # noqa: E731  signed, as the sort is
    firsts = F.filter("__h", lambda x, k: (k == 0) | (bin_of(x) != bin_of(F.get("__h", k - 1))))
    own = own.withColumn("__first", firsts).drop("__h")

    first = BINS // 2
    every = F.sequence(F.lit(-first).cast("long"), F.lit(first - 1).cast("long"))
    tries = np.random.default_rng(7).integers(0, BINS, (PROBES, BINS))
    probes = [F.array(*[F.lit(int(x)) for x in row]) for row in tries]

    def borrowed(j: Column) -> Column:
        """Of the bins that aren't empty the first in j's order."""
        nearest = F.array_min(F.transform("__first", lambda x: F.struct(F.xxhash64(j, bin_of(x)).alias("turn"), x.alias("x"))))
        return nearest["x"]

    def filled(bins: Column) -> Column:
        def slot(j: Column) -> Column:
            at = (j + first).cast("int")
            taken = F.coalesce(*[F.get(bins, F.get(probe, at)) for probe in probes], borrowed(j))
            return F.coalesce(F.get(bins, at), F.xxhash64(taken, j))

        return F.transform(every, slot)

    # As arguments of lambdas the map and the bins are built once for a text.
    by_bin = F.map_from_arrays(F.transform("__first", bin_of), "__first")
    bins = F.get(F.transform(F.array(by_bin), lambda by: F.transform(every, lambda j: F.try_element_at(by, j))), F.lit(0))
    slots = F.get(F.transform(F.array(bins), filled), F.lit(0))
    own = own.withColumn("__slots", F.when(F.size("__first") == BINS, F.col("__first")).otherwise(slots))

    def packed(i: Column) -> Column:
        low = [F.shiftleft(F.get("__slots", i * 8 + k).bitwiseAND(F.lit(255)), 8 * (7 - k)) for k in range(8)]
        total = low[0]
        for x in low[1:]:
            total = total.bitwiseOR(x)
        return total

    return own.withColumn(name, F.transform(F.sequence(F.lit(0), F.lit(LONGS - 1)), packed)).drop("__first", "__slots")


def likeness(a: Column, b: Column) -> Column:
    """Estimated share of common shingles, 0 to 1, from two fingerprints."""

    def unequal(x: Column, y: Column) -> Column:
        d = x.bitwiseXOR(y)
        for k in (4, 2, 1):
            d = d.bitwiseOR(F.shiftrightunsigned(d, k))
        return F.bit_count(d.bitwiseAND(F.lit(0x0101010101010101)))

    share = 1 - F.aggregate(F.zip_with(a, b, unequal), F.lit(0), lambda s, x: s + x) / F.lit(BINS)
    chance = 1 / 2**BITS
    return F.greatest(F.lit(0.0), (share - chance) / (1 - chance))


def hexadecimal(fingerprint: Column) -> Column:
    return F.array_join(F.transform(fingerprint, lambda x: F.lpad(F.lower(F.hex(x)), 16, "0")), "")


def with_next(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs (doc_id, text, others) with next_<column> of the following document.

    Documents are dealt out by ranges of doc_id whose upper bounds are ids of documents. The
    document at a bound also goes to the range above, where it follows the last one.
    """
    ranges = 2 * parallelism(docs.sparkSession)
    cuts = [i / ranges for i in range(1, ranges)]
    found = docs.agg(F.percentile_approx("doc_id", cuts, 10000), F.max("doc_id")).first()
    bounds, largest = sorted(set(found[0] or [])), found[1]
    bound = F.array(*[F.lit(x).cast("long") for x in bounds]) if bounds else F.array().cast("array<long>")
    at = F.size(F.filter(bound, lambda b: b < F.col("doc_id")))
    place = lambda range_, turn, echo: F.struct(range_.alias("range"), F.lit(turn).alias("turn"), F.lit(echo).alias("echo"))
    none = F.array().cast("array<struct<range:int,turn:int,echo:boolean>>")
    places = F.concat(
        F.array(place(at, 0, False)),
        F.when(F.array_contains(bound, F.col("doc_id")), F.array(place(at + 1, 0, True))).otherwise(none),
        F.when(F.col("doc_id").eqNullSafe(F.lit(largest)), F.array(place(F.lit(0), 1, True))).otherwise(none),
    )
    dealt = docs.select("*", F.explode(places).alias("__at"))
    dealt = dealt.withColumn("__range", F.col("__at.range"))
    order = Window.partitionBy("__range").orderBy(F.col("__at.turn"), F.desc_nulls_last("doc_id"), F.coalesce("text", F.lit("")))
    following = {f"next_{c}": F.lead(c).over(order) for c in columns}
    return dealt.withColumns(following).where(~F.col("__at.echo")).drop("__at", "__range")


def edited_fingerprints(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document (doc_id, text), of its text with the second half replaced by the
    beginning of the next document, and their likeness."""
    own = with_fingerprint(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")), "text", "fp")
    own = with_next(own, ["text", "fp"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.left(F.col("text"), F.length("text") - half), F.left(F.col("next_text"), half))
    own = own.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", edited)
    own = own.select("doc_id", "n_chars", "edited", F.sha2("edited", 256).alias("edited_sha256"), "fp", "next_fp")
    own = with_fingerprint(own, "edited", "edited_fp").drop("edited")
    return own.select(
        "doc_id", "n_chars", "edited_sha256",
        hexadecimal(F.col("fp")).alias("fingerprint"), hexadecimal(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"), likeness(F.col("fp"), F.col("next_fp")).alias("near_next"),
    )
