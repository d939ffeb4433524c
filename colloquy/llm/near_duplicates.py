"""Operator 6, SimHash near-duplicates by bit-sliced comparison.

A fingerprint bit is the majority of that bit over the hashes of a document's word shingles.
Fingerprints are compared within blocks of rows that agree on some of their bits. A block is stored
as bit planes: plane b holds bit b of 64 rows in one word. A fingerprint is compared with 64 others
at once: the planes, flipped where it has the bit set, go through a carry-save counter that
overflows once more than `radius` bits differ, and words of which all rows have overflowed are
dropped. Blocks give stars of links, and the links' components are found by star contraction.

Three sets of blocks:
* exact: 64 bits in eight bytes; two fingerprints that differ in at most two bits agree on six bytes,
  so the 28 choices of six bytes find all pairs, and a block, of distinct fingerprints that agree on
  48 bits, has at most 65,536 rows.
* sampled: for wide radii, blocks by random samples of the bits, as many samples as it takes to find
  a pair at the similarity threshold with the given recall.
* least: where shingle sets decide, blocks of texts whose least shingle is the same, by as many orders of
  all shingles as it takes to find such a pair with the given recall. Texts that share no shingle never
  meet: a share of all pairs lies within a wide radius by chance, and in a large table these links would
  tie most texts to one component.
A sampled or least block of more than `max_block` rows is compared chunk by chunk with itself in several
tasks; none of its pairs is lost.

With repeats = False near means more, and words are runs of letters and digits, whatever marks stand
between them. Two texts are near if at least the share `similarity` of the words of both together stands
in shingles that the other text has as well. (An edited word takes five shingles from a set, but leaves the
words around it covered by others; so this tells how much of two texts is the same, as shares of shingle
sets don't.) The blocks then only find candidates, by cosines of shingle sets of `candidates` on.
Candidates that hang together are compared again, and each link between two trees of links is kept
only if the two sets hold it. Texts go there once, or, of a component of more than `max_texts`, once
for each pair of chunks. Row numbers, fingerprints and links are all that is joined and contracted
before; the texts of a table are dealt out twice, to verify and to keep, at every size alike.

Defined results: a null or empty text has the fingerprint zero and is linked like any other; a text
with fewer words than a shingle is one shingle; repeated rows have equal fingerprints and are of one
group; a null doc_id counts as larger than all others. An empty table gives no rows.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, set_aside

LAST = 2**63 - 1
ROWS = 1 << 16
#: Links that a task connects at once.
EDGES = 1 << 20
WORDS = re.compile(r"[^\W_]+")


@dataclass(frozen=True)
class Near:
    shingle: int = 3
    #: 64 (XXH64) or 128 (XXH3).
    bits: int = 64
    radius: int = 2
    #: Whether a shingle that a text repeats counts each time. If not, shingle sets decide.
    repeats: bool = True
    #: Share of the words of two texts; the cosine of shingle sets from which on, and the chance with which, blocks find a pair; rows of a block.
    similarity: float = 0.8
    candidates: float = 0.65
    recall: float = 0.98
    max_block: int = 8192
    #: Texts whose sets a task holds at once.
    max_texts: int = 1024


#: What the contract of the query asks for, and what finds texts of which 0.8 comes again in five-word shingles.
EXACT = Near()
LIKE = Near(shingle=5, bits=128, radius=36, repeats=False)


def shingle_hashes(text: str | None, near: Near, ordered: bool = False) -> list[bytes]:
    """The hashes of a whole text's shingles; each once, in any order, if repeats don't count, unless all are asked for in order."""
    text = text or ""
    parts = text.encode().lower().split() if near.repeats else " ".join(WORDS.findall(text.lower())).encode().split()
    if not parts:
        return []
    ends = np.cumsum(np.fromiter(map(len, parts), dtype=np.int64, count=len(parts)) + 1) - 1
    joined = b" ".join(parts)
    starts = [0, *(ends[:-1] + 1).tolist()]
    ends = ends[min(near.shingle, len(parts)) - 1 :].tolist()
    digest = xxhash.xxh64_digest if near.bits == 64 else xxhash.xxh3_128_digest
    hashed = [digest(joined[s:e], 42) for s, e in zip(starts, ends)]
    return hashed if near.repeats or ordered else list(set(hashed))


def _majority(hashed: list[bytes], near: Near) -> bytes:
    counts = np.zeros(near.bits, dtype=np.int64)
    for at in range(0, len(hashed), ROWS):
        hashes = b"".join(hashed[at : at + ROWS])
        counts += np.unpackbits(np.frombuffer(hashes, dtype=np.uint8).reshape(-1, near.bits // 8), axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * counts > len(hashed)).tobytes()


def fingerprint(text: str | None, near: Near) -> bytes:
    """The big-endian fingerprint of a whole text."""
    return _majority(shingle_hashes(text, near), near)


def _last_words(hashed: list[bytes]) -> np.ndarray:
    """The last 64 bits of each hash."""
    return np.frombuffer(b"".join(h[-8:] for h in hashed), dtype="<u8")


@dataclass(frozen=True)
class Shingles:
    """A text's shingles in order, and as a sorted set."""

    run: np.ndarray
    each: np.ndarray


def shingles_of(text: str | None, near: Near) -> Shingles:
    run = _last_words(shingle_hashes(text, near, ordered=True))
    return Shingles(run, np.unique(run))


def _covered(a: Shingles, b: Shingles, near: Near) -> np.ndarray:
    """Which of a's words stand in shingles that b has."""
    at = np.minimum(np.searchsorted(b.each, a.run), len(b.each) - 1)
    return np.convolve(b.each[at] == a.run, np.ones(near.shingle)) > 0.5


def in_common(a: Shingles, b: Shingles, near: Near) -> float:
    """The share of the words of both texts that stand in shingles of the other as well."""
    if not len(a.run) or not len(b.run):
        return 0.0
    return float(np.concatenate([_covered(a, b, near), _covered(b, a, near)]).mean())


def _orders(near: Near) -> np.ndarray:
    """Odd factors, each of which puts all hashes in an order of its own.

    Two sets have the same least hash by an order with a chance of their Jaccard similarity, which is the
    square of their cosine at least, whatever their sizes.
    """
    tables = math.ceil(math.log(1 - near.recall) / math.log(1 - near.candidates**2))
    return np.random.default_rng(42).integers(0, 2**63, tables, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def least_hashes(hashes: np.ndarray, orders: np.ndarray) -> np.ndarray:
    """The least hash by each order; zeros for an empty set."""
    return np.array([(hashes * factor).min() for factor in orders] if len(hashes) else [0] * len(orders), dtype=np.uint64).astype(np.int64)


def with_fingerprints(docs: DataFrame, near: Near) -> DataFrame:
    """docs with the fingerprint as longs __f0 (and __f1), and with a number __row of its own for each row.

    Where shingle sets decide, __set is a digest of the set, the sum of its hashes, and __least has its least
    hash by each of several orders.
    """
    words = near.bits // 64
    fields = [*["__f0", "__f1"][:words], *([] if near.repeats else ["__set"])]
    turns = None if near.repeats else _orders(near)

    @F.pandas_udf(", ".join([*[f"{f} long" for f in fields], *([] if near.repeats else ["__least array<long>"])]))
    def prints(texts: pd.Series) -> pd.DataFrame:
        rows, least = [], []
        for hashed in (shingle_hashes(t, near) for t in texts):
            own = np.frombuffer(_majority(hashed, near), dtype=">i8").tolist()
            if not near.repeats:
                last = _last_words(hashed)
                own.append(int(last.sum(dtype=np.uint64).astype(np.int64)))
                least.append(least_hashes(last, turns))
            rows.append(own)
        found = pd.DataFrame(np.array(rows, dtype=np.int64).reshape(-1, len(fields)), columns=fields)
        return found if near.repeats else found.assign(__least=least)

    return docs.withColumn("__f", prints(F.coalesce(F.col("text"), F.lit("")))).select("*", "__f.*", F.monotonically_increasing_id().alias("__row")).drop("__f")


def _signed(x: int) -> int:
    return x - 2**64 if x >= 2**63 else x


def _exact_masks() -> list[list[int]]:
    return [[_signed(sum(0xFF << 8 * i for i in range(8) if i not in free))] for free in combinations(range(8), 2)]


def _sampled_masks(rows: int, near: Near) -> list[list[int]]:
    """Samples of so many bits that an even block has half of max_block rows at most, and 8 at least."""
    width = max(8, math.ceil(math.log2(max(1, rows) / (near.max_block / 2))))
    # Sets of one size have the share in common as their cosine; a bit agrees with chance 1 - angle / pi.
    agree = 1 - math.acos(near.candidates) / math.pi
    tables = math.ceil(math.log(1 - near.recall) / math.log(1 - agree**width))
    rng, masks = np.random.default_rng(42), []
    for _ in range(tables):
        chosen = set(rng.choice(near.bits, size=width, replace=False).tolist())
        masks.append([_signed(sum(1 << b for b in range(64) if 64 * word + b in chosen)) for word in range(near.bits // 64)])
    return masks


def _hits(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, near: Near) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i, j), i before j in the same block, of at most radius differing bits.

    values: rows of 64-bit words; starts and ends: of each row's block.
    """
    n = len(values)
    bits = np.unpackbits(np.ascontiguousarray(values.astype(">u8")).view(np.uint8).reshape(n, -1), axis=1)
    padded = np.zeros((-(-n // 64) * 64, bits.shape[1]), dtype=np.uint8)
    padded[:n] = bits
    planes = np.ascontiguousarray(np.packbits(padded, axis=0, bitorder="little").T).view("<u8")
    flip = np.where(bits.T == 1, np.uint64(2**64 - 1), np.uint64(0))
    varied = [b for b in range(bits.shape[1]) if bits[:, b].any() and not bits[:, b].all()]
    counters = (near.radius + 1).bit_length()
    first = 2**counters - (near.radius + 1)
    per_row = (ends - 1) // 64 - np.arange(n) // 64 + 1
    per_row[ends - np.arange(n) < 2] = 0
    todo, at = np.concatenate([[0], np.cumsum(per_row)]), 0
    ones = np.uint64(2**64 - 1)
    while at < n:
        stop = max(at + 1, int(np.searchsorted(todo, todo[at] + 32768, side="right")) - 1)
        row = np.repeat(np.arange(at, stop), per_row[at:stop])
        word = np.arange(len(row)) - np.repeat(todo[at:stop] - todo[at], per_row[at:stop]) + row // 64
        at = stop
        if not len(row):
            continue
        # Only rows after this one and in its block count.
        low = np.clip(row + 1 - 64 * word, 0, 64)
        high = np.clip(ends[row] - 64 * word, 0, 64)
        below = lambda k: np.where(k >= 64, ones, (np.uint64(1) << np.minimum(k, 63).astype(np.uint64)) - np.uint64(1))
        dead = ~(below(high) & ~below(low))
        count = [np.full(len(row), ones if first >> t & 1 else np.uint64(0)) for t in range(counters)]
        for turn, b in enumerate(varied):
            carry = planes[b][word] ^ flip[b][row]
            for t in range(counters):
                count[t], carry = count[t] ^ carry, count[t] & carry
            dead |= carry
            if turn % 4 == 3 and (alive := dead != ones).mean() < 0.8:
                row, word, dead, count = row[alive], word[alive], dead[alive], [c[alive] for c in count]
        alive = dead != ones
        row, word, near_by = row[alive], word[alive], np.ascontiguousarray(~dead[alive])
        lanes = np.unpackbits(near_by.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        cell, lane = np.nonzero(lanes)
        yield row[cell], 64 * word[cell] + lane


def verified_stars(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, near: Near, sets: list[Shingles]) -> np.ndarray:
    """As stars, by those hits alone whose sets are similar. A pair that is linked already needs no look."""
    label = np.arange(len(values))

    def root(x: int) -> int:
        while (up := label[x]) != x:
            x = up
        return x

    for a, b in _hits(values, starts, ends, near):
        for at in range(0, len(a), 4096):
            while ((up := label[label]) != label).any():
                label = up
            x, y = a[at : at + 4096], b[at : at + 4096]
            apart = label[x] != label[y]
            for i, j in zip(x[apart].tolist(), y[apart].tolist()):
                r, q = root(i), root(j)
                if r != q and in_common(sets[i], sets[j], near) >= near.similarity:
                    label[max(r, q)] = min(r, q)
    while ((up := label[label]) != label).any():
        label = up
    return label


def tied(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after the links (a, b): each row's is the first row that it is linked to, directly or not."""
    while True:
        # Only roots are tied to roots: what hung on a root before still does.
        while ((up := label[label]) != label).any():
            label = up
        x, y = label[a], label[b]
        apart = x != y
        if not apart.any():
            return label
        a, b = a[apart], b[apart]
        np.minimum.at(label, np.maximum(x, y)[apart], np.minimum(x, y)[apart])


def stars(values: np.ndarray, starts: np.ndarray, ends: np.ndarray, near: Near) -> np.ndarray:
    """For each row the first row that it is linked to, directly or not, within its block."""
    label = np.arange(len(values))
    for a, b in _hits(values, starts, ends, near):
        label = tied(label, a, b)
    return label


def _link(near: Near, fields: list[str], keys: list[str], verify: bool = False):
    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of their blocks; a block that a batch breaks off waits for the next."""
        held: list[np.ndarray] = []
        sets: list[Shingles] = []  # of the rows held
        enough = near.max_texts if verify else ROWS

        def linked(rows: np.ndarray, sets: list[Shingles]) -> pa.RecordBatch:
            block = rows[:, : len(keys)]
            new = np.concatenate([[True], (block[1:] != block[:-1]).any(axis=1)])
            begins = np.flatnonzero(new)
            sizes = np.diff(np.append(begins, len(rows)))
            several = np.repeat(sizes > 1, sizes)  # rows alone in their block are done
            rows, sizes = rows[several], sizes[sizes > 1]
            begins = np.cumsum(sizes) - sizes
            starts, ends = np.repeat(begins, sizes), np.repeat(begins + sizes, sizes)
            values = rows[:, len(keys) + 1 :].astype(np.uint64)
            if not len(rows):
                first = np.zeros(0, dtype=np.int64)
            elif verify:
                first = verified_stars(values, starts, ends, near, [sets[i] for i in np.flatnonzero(several)])
            else:
                first = stars(values, starts, ends, near)
            own, other = rows[:, len(keys)], rows[first, len(keys)]
            link = own != other
            return pa.RecordBatch.from_arrays([pa.array(np.maximum(own, other)[link]), pa.array(np.minimum(own, other)[link])], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            held.append(np.stack([batch.column(c).to_numpy() for c in [*keys, "node", *fields]], axis=1))
            if verify:
                sets += [shingles_of(t, near) for t in batch.column("text").to_pylist()]
            if sum(map(len, held)) >= enough:
                rows = np.concatenate(held)
                last = len(rows) - int((rows[:, : len(keys)] != rows[-1, : len(keys)]).any(axis=1)[::-1].argmax())
                if last == len(rows) and not (rows[:, : len(keys)] != rows[-1, : len(keys)]).any():
                    last = 0
                held = [rows[last:]]
                if last:
                    yield linked(rows[:last], sets[:last])
                    sets = sets[last:]
        if held and len(rows := np.concatenate(held)):
            yield linked(rows, sets)

    return link


def _chunked(keyed: DataFrame, keys: list[str], size: int, name: str) -> DataFrame:
    """keyed with chunks c0 and c1: a block of more than size rows is dealt to each pair of its chunks."""
    sizes = keyed.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > size)
    sizes = materialize(sizes.withColumn("parts", F.ceil(F.col("n") / (size / 2))).drop("n"), name)
    chunk = F.pmod(F.xxhash64("node"), F.col("parts"))
    other = F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).otherwise(F.array(F.lit(0).cast("long")))
    keyed = keyed.join(sizes, keys, "left").withColumn("own", F.coalesce(chunk, F.lit(0))).withColumn("other", F.explode(other))
    return keyed.withColumns({"c0": F.least("own", "other"), "c1": F.greatest("own", "other")})


def links(distinct: DataFrame, near: Near) -> DataFrame:
    """Links (a, b), a after b, between the nodes of distinct fingerprints, enough to connect all that are near.

    Where shingle sets decide, distinct has __least as well.
    """
    fields = [c for c in distinct.columns if c in ("__f0", "__f1")]
    exact = near.bits == 64 and near.radius <= 2
    if exact or near.repeats:
        masks = _exact_masks() if exact else _sampled_masks(distinct.count(), near)
        blocks = F.explode(F.array(*[F.struct(F.lit(i).cast("long").alias("t"), *[F.col(f).bitwiseAND(F.lit(m)).alias(f"k{w}") for w, (f, m) in enumerate(zip(fields, mask))]) for i, mask in enumerate(masks)]))
        keyed = distinct.select("node", *fields, blocks.alias("__b")).select("node", *fields, "__b.*")
        keys = ["t", *[f"k{w}" for w in range(len(fields))]]
    else:
        keyed = distinct.select("node", *fields, F.posexplode("__least").alias("t", "k")).withColumn("t", F.col("t").cast("long"))
        keys = ["t", "k"]
    if not exact:
        keyed = _chunked(keyed, keys, near.max_block, "near-large")
        keys = [*keys, "c0", "c1"]
    dealt = keyed.select(*keys, "node", *fields).repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(_link(near, fields, keys), "a long, b long")


def verified_links(distinct: DataFrame, candidates: DataFrame, docs: DataFrame, near: Near) -> DataFrame:
    """Links (a, b) between similar sets, enough to connect all that are similar, within each component of candidates.

    distinct: nodes with fingerprints; candidates: (node, component); docs: texts by __row, which nodes are.
    """
    fields = [c for c in distinct.columns if c in ("__f0", "__f1")]
    keys = ["component", "c0", "c1"]
    nodes = materialize(_chunked(distinct.join(candidates, "node"), ["component"], near.max_texts, "near-chunks").select(*keys, "node", *fields), "near-candidates")
    texts = docs.select(F.col("__row").alias("node"), F.coalesce("text", F.lit("")).alias("text"))
    dealt = texts.join(nodes.hint("shuffle_hash"), "node").select(*keys, "node", *fields, "text").repartition(*keys).sortWithinPartitions(*keys, "node")
    return dealt.mapInArrow(_link(near, fields, keys, verify=True), "a long, b long")


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The links of a task, each to the smallest node that they connect it to. At most `EDGES` are held."""
    held: list[np.ndarray] = []

    def trees() -> pa.RecordBatch:
        nodes, ends = np.unique(np.concatenate(held, axis=1), return_inverse=True)
        a, b = ends.reshape(2, -1)
        label = tied(np.arange(len(nodes)), a, b)
        own = label != np.arange(len(nodes))
        held.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes[own]), pa.array(nodes[label[own]])], names=["a", "b"])

    for batch in batches:
        held.append(np.stack([batch.column(c).to_numpy() for c in "ab"]))
        if sum(x.shape[1] for x in held) >= EDGES:
            yield trees()
    if held:
        yield trees()


def components(edges: DataFrame) -> DataFrame:
    """(node, component), the smallest node of each component, for all nodes of edges (a, b), a after b.

    Each task first connects the links it reads by itself. Then large-star and small-star contraction:
    after each round a node points to smaller ones, until the links are stars. Least neighbours are
    written before they are joined, so that a node of many links can be split there.
    """

    def state(e: DataFrame) -> tuple:
        return tuple(e.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())

    edges = materialize(materialize(edges, "links-given").mapInArrow(_forest, "a long, b long").distinct(), "links")
    now = state(edges)
    while True:
        # Of a node's neighbours those after it go to its least one; those of a root already do.
        least = materialize(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("b"), "m"), "links-least")
        moved = edges.join(least, "b").select("a", F.col("m").alias("b"))
        large = materialize(edges.join(least, "b", "left_anti").select("a", "b").unionByName(moved).distinct(), "links-large")
        # Where several smaller ones are left, all of them go to the least.
        several = large.groupBy("a").agg(F.min("b").alias("m"), F.max("b").alias("most"))
        least = materialize(several, "links-least")
        small = large.join(least.where("m < most").select("a", "m"), "a").where(F.col("b") != F.col("m")).select(F.col("b").alias("a"), F.col("m").alias("b"))
        edges = materialize(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "links")
        before, now = now, state(edges)
        if now == before:
            break
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots.withColumn("component", F.col("node")))


def near_duplicate_groups(docs: DataFrame, near: Near = EXACT, keep_text: bool = True) -> tuple[DataFrame, DataFrame]:
    """docs with fingerprints and row numbers, and (fingerprint, component, component_id, first row).
    Where shingle sets decide, a fingerprint comes once for each set that has it.

    component_id is the smallest doc_id of the component; the first row is of that doc_id.
    """
    own = with_fingerprints(docs.drop(*(c for c in docs.columns if c in ("__f0", "__f1", "__set", "__least", "__row"))), near)
    own = materialize(own if keep_text or not near.repeats else own.drop("text"), "near-docs")
    fields = ["__f0", "__f1"][: near.bits // 64]
    same = fields if near.repeats else [*fields, "__set"]
    first = F.min(F.struct(F.coalesce(F.col("doc_id"), F.lit(LAST)).alias("id"), F.col("__row").alias("row")))
    distinct = own.groupBy(*same).agg(F.min("__row").alias("node"), first.alias("first"), *([] if near.repeats else [F.min("__least").alias("__least")]))
    distinct = materialize(distinct, "near-distinct")
    nodes = distinct.select("node", *fields, *([] if near.repeats else ["__least"]))
    found = materialize(components(links(nodes, near)), "near-components")
    if not near.repeats:
        found = materialize(components(verified_links(nodes, found, own, near)), "near-verified")
    labelled = materialize(distinct.join(found, "node", "left").withColumn("component", F.coalesce("component", "node")), "near-labelled")
    # Written before they are joined, so that a component of many fingerprints can be split there.
    firsts = materialize(labelled.groupBy("component").agg(F.min("first").alias("head")), "near-firsts")
    groups = labelled.select(*same, "component").join(firsts, "component")
    return own, materialize(groups.select(*same, "component", F.nullif(F.col("head.id"), F.lit(LAST)).alias("component_id"), F.col("head.row").alias("__first")), "near-groups")


def hexadecimal(long: Column) -> Column:
    return F.lpad(F.lower(F.hex(long)), 16, "0")


def drop_near_duplicates(docs: DataFrame, near: Near = LIKE) -> DataFrame:
    """docs without all but one document of each group of near-duplicates."""
    docs, named = set_aside(docs)
    given = docs.columns
    own, groups = near_duplicate_groups(docs, near)
    kept = groups.select(F.col("__first").alias("__row")).distinct()
    return own.join(kept.hint("shuffle_hash"), "__row", "left_semi").transform(lambda kept_docs: named(kept_docs.select(*given)))
