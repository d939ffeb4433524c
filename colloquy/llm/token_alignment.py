"""Operator 11, alignment of the tokens of two tokenizers, with corpus-wide counts by minimal perfect hashing.

Both tokenizers spell the same bytes, a space and the text. Offsets where tokens of both end cut a
document into groups; a link is a pair of tokens whose bytes overlap, and there is one for each
offset where a token of either ends. The count of a pair of ids is how many links hold it.

1. Documents are encoded once; ids are written.
2. First pass: tasks align and count pairs, and emit each pair that they saw once.
3. The distinct pairs are dealt into buckets of some BUCKET pairs, and each gets a minimal perfect hash:
   level by level, a pair takes the bit that its hash points to if no other left pair of the bucket wants it;
   a pair's number is the rank of its bit. Pairs are kept by their number, to verify what is looked up.
4. Counts of FAN partitions become one dense vector for each bucket, indexed by the hash; such vectors are
   summed FAN at a time, as a tree, until there is one.
5. Second pass: documents are aligned again, and counts looked up. The table of hashes, pairs and counts is
   sent to the tasks in parts of PART_BYTES at most, however large it is: sums over links are added up over the
   parts, and with one part (some four million pairs) documents are read once. The highest count of each id of
   the second tokenizer is a vector of its vocabulary's size.

Defined results: null and empty texts, and texts that a tokenizer doesn't spell as they are (the second
one may write U+2581 for a space, say), have no tokens, links or groups: zeros; rows that are repeated
count each; an empty table gives no rows; texts of any length are aligned whole; columns besides doc_id
and text, whatever their names, are not read. Strings of special tokens are plain text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

FIRST, SECOND = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
BUCKET, FAN, PART_BYTES = 4096, 16, 64 << 20
#: Distinct pairs that a task holds before it emits them.
HELD = 2_000_000
_PRIME, _ODD = 4294967291, 1540483477


def _byte_letters() -> dict[str, int]:
    """The byte of each letter of byte-level vocabularies: itself if it prints, the others from 256 on in order."""
    prints = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(prints)]
    return {chr(b): b for b in prints} | {chr(256 + k): b for k, b in enumerate(others)}


class Spelling:
    """The bytes of each id, one after the other."""

    def __init__(self, spelled: list[bytes]) -> None:
        self.lengths = np.array([len(s) for s in spelled], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.bytes = np.frombuffer(b"".join(spelled), np.uint8)

    def of(self, ids: np.ndarray) -> np.ndarray:
        n = self.lengths[ids]
        ends = np.cumsum(n)
        return self.bytes[np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.starts[ids] - ends + n, n)]


class Tokenizers:
    """The byte-level vocabulary runs on tiktoken, which merges by rank as the file's own library does and is some four times as fast."""

    def __init__(self, first: str, second: str) -> None:
        import sentencepiece
        import tiktoken

        letters = _byte_letters()
        with open(first, encoding="utf-8") as file:
            vocabulary = json.load(file)["model"]["vocab"]
        spelled = {i: bytes(letters[c] for c in token) for token, i in vocabulary.items() if all(c in letters for c in token)}
        special = {i for token, i in vocabulary.items() if re.fullmatch(r"<\|\w+\|>", token)}
        ranks = {s: i for i, s in spelled.items() if i not in special}
        self.encoding = tiktoken.Encoding("first", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.first = Spelling([spelled.get(i, b"") for i in range(max(spelled) + 1)])
        self.pieces = sentencepiece.SentencePieceProcessor(model_file=second)
        names = [self.pieces.id_to_piece(i) for i in range(self.pieces.get_piece_size())]
        self.second = Spelling([bytes([int(p[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", p) else p.replace("▁", " ").encode() for p in names])

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a text, none if either tokenizer spells it differently."""
        none = np.empty(0, np.int64)
        if not text:
            return none, none
        whole = np.frombuffer(b" " + text.encode(), np.uint8)
        a = np.array(self.encoding.encode_ordinary(" " + text), np.int64)
        b = np.array(self.pieces.encode(text), np.int64)
        # The first one's ids are of bytes, which spell any text as it is; their number tells if they don't.
        same = all(int(s.lengths[ids].sum()) == len(whole) for s, ids in ((self.second, b), (self.first, a))) and np.array_equal(self.second.of(b), whole)
        return (a, b) if same else (none, none)


@lru_cache(maxsize=1)
def tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


class Alignment:
    """The tokens of several documents, one after the other: as each spells the same bytes twice, they align as one text."""

    def __init__(self, tools: Tokenizers, batch: pa.RecordBatch) -> None:
        read = lambda column: [np.frombuffer(x.as_buffer(), "<u4") for x in batch.column(column)]
        a, b = read("a"), read("b")
        self.n_a, self.n_b = (np.array([len(x) for x in own], np.int64) for own in (a, b))
        self.a, self.b = (np.concatenate([np.empty(0, "<u4"), *own]).astype(np.int64) for own in (a, b))
        a_ends, b_ends = np.cumsum(tools.first.lengths[self.a]), np.cumsum(tools.second.lengths[self.b])
        # Links in order: each ends where a token of either ends, so that one of the first tokenizer comes after its fellows
        # and after those of the second alone that end before it.
        at = np.searchsorted(a_ends, b_ends)
        both = a_ends[at] == b_ends if len(at) else np.zeros(0, bool)
        place = np.arange(len(a_ends)) + np.cumsum(np.bincount(at[~both], minlength=len(a_ends) + 1))[: len(a_ends)]
        #: Whether a group ends with each token.
        self.a_last, self.b_last = np.zeros(len(a_ends), bool), both
        self.a_last[at[both]] = True
        links = len(a_ends) + int(len(both) - both.sum())
        ends_a, ends_b = np.zeros(links, bool), np.ones(links, bool)
        ends_a[place], ends_b[place] = True, self.a_last
        self.link_a, self.link_b = (ids[np.cumsum(ends) - ends] for ids, ends in ((self.a, ends_a), (self.b, ends_b)))
        self.width = len(tools.second.lengths)
        # Where each document's links and groups end.
        self.link_stops, self.group_stops = (np.concatenate([[0], x])[np.cumsum(self.n_a)] for x in (place + 1, np.cumsum(self.a_last)))

    def pairs(self) -> np.ndarray:
        return self.link_a * self.width + self.link_b

    def documents(self) -> np.ndarray:
        """The document of each link."""
        return np.repeat(np.arange(len(self.n_a)), np.diff(self.link_stops, prepend=0))


def _encode(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(first, second)
        for batch in batches:
            found = [tools.encode(x.as_py()) for x in batch.column("text")]
            columns = [pa.array([ids[k].astype("<u4").tobytes() for ids in found], pa.binary()) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", "a", "b"])

    return run


def _sums(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    starts = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[starts], np.add.reduceat(counts, starts)


def _count(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools, leaf = tokenizers(first, second), TaskContext.get().partitionId() // FAN
        held, waiting = [], 0

        def rows() -> Iterator[pa.RecordBatch]:
            keys, counts = held.pop()
            for at in range(0, len(keys), 65_536):
                part = slice(at, at + 65_536)
                n = len(keys[part])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(n, leaf, np.int64)), pa.array(keys[part]), pa.array(counts[part])], ["leaf", "pair", "n"])

        for batch in batches:
            keys, counts = np.unique(Alignment(tools, batch).pairs(), return_counts=True)
            held.append((keys, counts.astype(np.int64)))
            waiting += len(keys)
            if waiting > HELD:
                held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
                waiting = len(held[0][0])
                if waiting > HELD // 2:
                    yield from rows()
                    waiting = 0
        if held:
            held = [_sums(*map(np.concatenate, zip(*held, strict=True)))]
            yield from rows()

    return run


def _bucket_of(pairs: np.ndarray, buckets: int) -> np.ndarray:
    x = (pairs.astype(np.uint64) % np.uint64(_PRIME) * np.uint64(_ODD)) & np.uint64(0xFFFFFFFF)
    return (x * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)


def _bucket_column(buckets: int):
    x = F.pmod(F.pmod(F.col("pair"), F.lit(_PRIME)) * F.lit(_ODD), F.lit(1 << 32))
    return F.shiftright(x * F.lit(buckets), 32).cast("int").alias("bucket")


def _hash(pairs: np.ndarray, level: int) -> np.ndarray:
    x = pairs.astype(np.uint64) + np.uint64((level + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def build_hash(pairs: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Bits by level, and all bits: two for each pair that is left. Pairs are distinct."""
    sizes, bits, left, level = [], [], pairs, 0
    while len(left):
        size = 2 * len(left)
        at = (_hash(left, level) % np.uint64(size)).astype(np.int64)
        alone = np.bincount(at, minlength=size) == 1
        sizes.append(size)
        bits.append(alone)
        left, level = left[~alone[at]], level + 1
    return sizes, np.concatenate([np.empty(0, bool), *bits])


class Numbering:
    """Minimal perfect hashes of a range of buckets as one: numbers from 0 in the order of buckets."""

    def __init__(self, first_bucket: int, buckets: int, sizes: list[list[int]], bits: list[np.ndarray]) -> None:
        self.first, self.buckets, self.held = first_bucket, buckets, len(sizes)
        levels = max([len(s) for s in sizes], default=0)
        self.sizes = np.zeros((levels, len(sizes)), np.int64)
        for k, own in enumerate(sizes):
            self.sizes[: len(own), k] = own
        flat = self.sizes.T.reshape(-1)
        self.offsets = (np.cumsum(flat) - flat).reshape(len(sizes), levels).T
        self.bits = np.concatenate([np.zeros(0, bool), *bits])
        self.ranks = np.cumsum(self.bits) - self.bits

    def of(self, pairs: np.ndarray) -> np.ndarray:
        """The number of each pair; -1 if it is in no bucket of the range, or in none at all."""
        out = np.full(len(pairs), -1, np.int64)
        bucket = _bucket_of(pairs, self.buckets) - self.first
        left = np.flatnonzero((bucket >= 0) & (bucket < self.held))
        for level in range(len(self.sizes)):
            sizes = self.sizes[level][bucket[left]]
            left, sizes = left[sizes > 0], sizes[sizes > 0]
            at = (_hash(pairs[left], level) % sizes.astype(np.uint64)).astype(np.int64) + self.offsets[level][bucket[left]]
            hit = self.bits[at]
            out[left[hit]] = self.ranks[at[hit]]
            left = left[~hit]
        return out


def _build(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, bits, keys = [], [], []
            for bucket, pairs in zip(batch.column("bucket").to_pylist(), batch.column("pairs"), strict=True):
                pairs = pairs.values.to_numpy(zero_copy_only=False)
                size, bit = build_hash(pairs)
                ordered = np.empty_like(pairs)
                ordered[Numbering(bucket, buckets, [size], [bit]).of(pairs)] = pairs
                sizes.append(size)
                bits.append(np.packbits(bit).tobytes())
                keys.append(ordered)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), pa.array(sizes, pa.list_(pa.int32())), pa.array(bits, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["bucket", "sizes", "bits", "keys"])

    return run


def _unpacked(sizes: list[int], bits: bytes) -> np.ndarray:
    return np.unpackbits(np.frombuffer(bits, np.uint8), count=sum(sizes)).astype(bool)


def _dense(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = []
            for row, pairs, counts in zip(batch.select(["bucket", "sizes", "bits"]).to_pylist(), batch.column("pairs"), batch.column("counts"), strict=True):
                numbers = Numbering(row["bucket"], buckets, [row["sizes"]], [_unpacked(row["sizes"], row["bits"])])
                vector = np.zeros(int(numbers.bits.sum()), np.int64)
                vector[numbers.of(pairs.values.to_numpy(zero_copy_only=False))] = counts.values.to_numpy(zero_copy_only=False)
                vectors.append(vector)
            yield pa.RecordBatch.from_arrays([batch.column("bucket"), batch.column("leaf"), pa.array(vectors, pa.list_(pa.int64()))], ["bucket", "leaf", "vector"])

    return run


def pair_counts(tokens: DataFrame, first: str = FIRST, second: str = SECOND) -> tuple[DataFrame, int, int]:
    """(bucket, sizes, bits, keys, vector), the hash of each bucket with its pairs and their counts; how many buckets and pairs there are."""
    local = materialize(tokens.mapInArrow(_count(first, second), "leaf long, pair long, n long"), "pairs", drop_shuffles=True)
    pairs = materialize(local.select("pair").distinct(), "distinct-pairs", drop_shuffles=True)
    total = pairs.count()
    buckets = -(-total // BUCKET) or 1
    dealt = pairs.select(_bucket_column(buckets), "pair").groupBy("bucket").agg(F.collect_list("pair").alias("pairs"))
    hashes = materialize(dealt.mapInArrow(_build(buckets), "bucket int, sizes array<int>, bits binary, keys array<long>"), "hashes", drop_shuffles=True)

    leaves = (local.agg(F.max("leaf")).first()[0] or 0) + 1
    counted = local.groupBy(_bucket_column(buckets), "leaf", "pair").agg(F.sum("n").alias("n"))
    counted = counted.groupBy("bucket", "leaf").agg(F.collect_list(F.struct("pair", "n")).alias("c")).select("bucket", "leaf", F.col("c.pair").alias("pairs"), F.col("c.n").alias("counts"))
    vectors = counted.join(hashes.select("bucket", "sizes", "bits"), "bucket").select("bucket", "leaf", "pairs", "counts", "sizes", "bits")
    vectors = materialize(vectors.mapInArrow(_dense(buckets), "bucket int, leaf long, vector array<long>"), "vectors", drop_shuffles=True)
    while leaves > 1:
        leaves = -(-leaves // FAN)
        grouped = vectors.groupBy("bucket", F.floor(F.col("leaf") / FAN).alias("leaf")).agg(F.collect_list("vector").alias("v"))
        added = F.aggregate(F.slice("v", 2, FAN), F.element_at("v", 1), lambda x, y: F.zip_with(x, y, lambda p, q: p + q))
        vectors = materialize(grouped.select("bucket", "leaf", added.alias("vector")), "vectors", drop_shuffles=True)
    return materialize(hashes.join(vectors.select("bucket", "vector"), "bucket"), "counts", drop_shuffles=True), buckets, total


def _look_up(first: str, second: str, table, best, new: bool):
    """Adds n_best and count_sum of the links whose pairs are in the table's part; new: of no part before."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(first, second)
        numbers, keys, counts, highest = *table.value, best.value
        for batch in batches:
            aligned = Alignment(tools, batch)
            pairs, documents = aligned.pairs(), aligned.documents()
            number = numbers.of(pairs)
            here = number >= 0
            if not np.array_equal(keys[number[here]], pairs[here]):
                raise ValueError("a pair of ids is not among those that were counted")
            count = counts[number[here]]
            sums, bests = np.zeros(len(aligned.n_a), np.int64), np.zeros(len(aligned.n_a), np.int64)
            np.add.at(sums, documents[here], count)
            np.add.at(bests, documents[here], (count == highest[pairs[here] % aligned.width]).astype(np.int64))
            if not new:
                sums, bests = (x + batch.column(c).to_numpy(zero_copy_only=False) for x, c in ((sums, "count_sum"), (bests, "n_best")))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in ("doc_id", "a", "b")), pa.array(bests), pa.array(sums)], ["doc_id", "a", "b", "n_best", "count_sum"])

    return run


def align(docs: DataFrame, first: str = FIRST, second: str = SECOND, part_bytes: int = PART_BYTES) -> DataFrame:
    """(doc_id, a, b, n_best, count_sum): a and b are the ids of both tokenizers, little-endian unsigned 32-bit."""
    spark, kind = docs.sparkSession, docs.schema["doc_id"].dataType.simpleString()
    texts = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    tokens = materialize(texts.mapInArrow(_encode(first, second), f"doc_id {kind}, a binary, b binary"), "tokens", drop_shuffles=True)
    counts, buckets, total = pair_counts(tokens, first, second)

    width = len(tokenizers(first, second).second.lengths)
    each = counts.select(F.explode(F.arrays_zip("keys", "vector")).alias("p"))
    highest = np.zeros(width, np.int64)
    for row in each.groupBy(F.pmod("p.keys", F.lit(width)).alias("b")).agg(F.max("p.vector").alias("n")).collect():  # one for each id of the vocabulary at most
        highest[row["b"]] = row["n"]
    best = spark.sparkContext.broadcast(highest)

    # A pair takes 17 bytes, and the bits of its hash some 20 more once they are unpacked.
    parts = max(1, -(-total * 40 // part_bytes))
    schema, found = f"doc_id {kind}, a binary, b binary, n_best long, count_sum long", tokens
    for part in range(parts):
        start, stop = (buckets * k // parts for k in (part, part + 1))
        rows = {r["bucket"]: r for r in counts.where(F.col("bucket").between(start, stop - 1)).collect()}
        empty = {"sizes": [], "bits": b"", "keys": [], "vector": []}
        rows = [rows.get(b, empty) for b in range(start, stop)]
        numbers = Numbering(start, buckets, [list(r["sizes"]) for r in rows], [_unpacked(r["sizes"], bytes(r["bits"])) for r in rows])
        flat = [np.concatenate([np.empty(0, np.int64), *(np.array(r[c], np.int64) for r in rows)]) for c in ("keys", "vector")]
        table = spark.sparkContext.broadcast((numbers, *flat))
        found = found.mapInArrow(_look_up(first, second, table, best, part == 0), schema)
    return found


SEPARATORS = ",|;"


def _describe(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tools = tokenizers(first, second)
        most = max(len(tools.first.lengths), len(tools.second.lengths))
        strings = [f"{i}{s}" for i in range(most) for s in SEPARATORS]
        for batch in batches:
            x = Alignment(tools, batch)
            # Tokens in the order of groups, those of the first tokenizer before those of the second.
            a_stops, b_stops = np.flatnonzero(x.a_last) + 1, np.flatnonzero(x.b_last) + 1
            of_a, of_b = np.cumsum(x.a_last) - x.a_last, np.cumsum(x.b_last) - x.b_last
            codes = np.empty(len(x.a) + len(x.b), np.int64)
            codes[np.arange(len(x.a)) + np.concatenate([[0], b_stops])[of_a]] = x.a * 3 + x.a_last
            codes[np.arange(len(x.b)) + np.concatenate([a_stops, [0]])[of_b]] = x.b * 3 + 2 * x.b_last
            digests, at = [], 0
            for n in (x.n_a + x.n_b).tolist():
                text = "".join([strings[c] for c in codes[at : at + n].tolist()])[:-1]
                digests.append(hashlib.sha256(text.encode()).hexdigest() if n else "")
                at += n
            numbers = [x.n_a, x.n_b, np.diff(x.group_stops, prepend=0), np.diff(x.link_stops, prepend=0)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(n.astype(np.int64)) for n in numbers), batch.column("n_best"), batch.column("count_sum"), pa.array(digests, pa.string())],
                ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"],
            )

    return run


def described(aligned: DataFrame, first: str = FIRST, second: str = SECOND) -> DataFrame:
    """What align returns, with numbers of tokens, groups and links, and the SHA-256 of the groups, in place of the ids."""
    kind = aligned.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return materialize(aligned.mapInArrow(_describe(first, second), schema), "aligned", drop_shuffles=True)
